"""Personal data: fixed formats, and identifiers that bootstrapped contexts find.

Values of the formats (``email``, ``ip``, ``card``, ``phone``) and identifiers of unmistakable shape
are the seeds. A *pattern* is a way of writing an identifier: a cue (a word with ``=`` or ``:``), the
word of prose before or after it, or its first letters, with its shape. Patterns and the values that
they extract form a graph. Reliability flows from the seeds to the patterns that extract them, from
there to the other values of these patterns, and so on (Pantel and Pennacchiotti's Espresso). What
the patterns of high reliability extract is added as kind ``id``; a seed whose patterns are not
reliable is no such span.

A word of prose stands before other words too, so its reliability is the share of all its occurrences
in the corpus that have a trusted value there. Values of letters only are no candidates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import keep, texts_of

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "id")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# An identifier candidate: a run of letters and digits with both, of 12 characters or more.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,}+")
# After a cue, also numbers of any length with separators, and shorter runs with a digit.
_SIGN = re.compile(r"[=:]\s?[\"']?(?=[+(A-Za-z0-9])")
_NUMBER = re.compile(r"\+?\(?[0-9]++(?:[\x20().\-/]{1,2}[0-9]++)*+(?![A-Za-z0-9])")
_RUN = re.compile(r"(?=[A-Za-z]*[0-9])[A-Za-z0-9]++")
_HEX = re.compile(r"[0-9a-f]+")
# Cues and words of more than 24 letters are none; the slices searched are long enough to see that.
_CUE = re.compile(r"(?:(?<![^\W\d_])([^\W\d_]{1,24}))?(\s?[=:]\s?[\"']?)$")
_BEFORE = re.compile(r"(?<!\w)([^\W\d_]{2,24})\s$")
_AFTER = re.compile(r"\s([^\W\d_]{2,24})(?!\w)")
_WORD = re.compile(r"(?<!\w)[^\W\d_]{2,24}(?!\w)")
_OPENS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+(")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed formats in code points, by start, then in ``KINDS`` order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGITS.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return [(s, e, KINDS[k]) for s, k, e in found]


def shape(value: str) -> str:
    """What kind of characters a value has and how many, to the nearest power of two below."""
    if _HEX.fullmatch(value):
        letters = "hex"
    else:
        letters = "".join(
            c for c, has in (("A", value.upper() != value.lower() and any(map(str.isupper, value))),
                             ("a", any(map(str.islower, value)))) if has
        )
    return f"{letters}{1 << (len(value).bit_length() - 1)}"


def digits_of(value: str) -> str:
    """How many digits a number has, to the nearest power of two below."""
    return f"d{1 << (len(_NOT_DIGITS.sub('', value)).bit_length() - 1)}"


def word_patterns(text: str, start: int, stop: int, forms: tuple[str, str]) -> list[str]:
    """Patterns of the words of prose next to a value; ``forms`` from special to general."""
    found = []
    before = _BEFORE.search(text[max(0, start - 27) : start])
    if before:
        found += [f"after {before[1].lower()} {f}" for f in forms]
    after = _AFTER.match(text[stop : stop + 27])
    if after:
        found += [f"before {after[1].lower()} {f}" for f in forms]
    return found


def in_prose(
    text: str, base: list[tuple[int, int, str]]
) -> Iterator[tuple[int, int, tuple[str, str]]]:
    """(start, end, forms) of numbers and of runs with a digit that meet no span of ``base``."""
    at, b = 0, 0
    digit = _DIGITS.search(text)
    while digit:
        start = digit.start()
        while start > at and text[start - 1] in _OPENS:
            start -= 1
        number = _NUMBER.match(text, start)
        run = number or _RUN.match(text, start) or digit
        at = run.end()
        while b < len(base) and base[b][1] <= start:
            b += 1
        if b < len(base) and base[b][0] < at:
            at = max(at, base[b][1])
        elif run is not digit:
            value = run[0]
            yield start, at, (digits_of(value), "number") if number else (shape(value), "run")
        digit = _DIGITS.search(text, at)


def candidates(
    text: str, base: list[tuple[int, int, str]] | None = None
) -> list[tuple[int, int, str, list[str], bool]]:
    """(start, end, value, patterns, seed) of the identifier candidates of a text.

    Patterns go from special to general: cue word with delimiter and shape, cue word with
    delimiter, delimiter with shape, fixed lead letters with shape, and words next to the value. A
    seed is 32 or more hexadecimal digits, or 16 or more capitals and digits: nobody writes words
    like that. So is what the fixed formats find (``base``) in a context; an email stands for what
    names a person. One value may come several times, with patterns of different kinds.
    """
    found = []
    if base is None:
        base = base_spans(text)
    for m in _CANDIDATE.finditer(text):
        value, form = m[0], shape(m[0])
        patterns = []
        cue = _CUE.search(text[max(0, m.start() - 30) : m.start()])
        if cue:
            sign = "".join(cue[2].split())
            if cue[1]:
                patterns += [f"cue {cue[1].lower()}{sign} {form}", f"cue {cue[1].lower()}{sign[0]} run"]
            patterns.append(f"sign {sign[0]} {'hex' if form.startswith('hex') else form}")
        if value[:4].isalpha():
            patterns.append(f"lead {value[:4]} {form}")
        seed = (len(value) >= 32 and form.startswith("hex")) or (
            len(value) >= 16 and value.upper() == value
        )
        found.append((m.start(), m.end(), value, patterns, seed))
    starts = {f[0]: f for f in found}
    for start, stop, kind in base:
        value = text[start:stop]
        forms = ("run", "run") if kind == "email" else (digits_of(value), "number")
        patterns = word_patterns(text, start, stop, forms)
        if patterns:
            found.append((start, stop, value, sorted(set(patterns)), True))
    for start, stop, forms in in_prose(text, base):
        patterns = word_patterns(text, start, stop, forms)
        known = starts.get(start)
        if patterns and known:
            known[3].extend(patterns)
        elif patterns:
            found.append((start, stop, text[start:stop], patterns, False))
    fixed = {s: (e, kind) for s, e, kind in base}
    at = 0  # the first base span that ends after the next value starts
    for m in _SIGN.finditer(text):
        start = m.end()
        cue = _CUE.search(text[max(0, start - 30) : start])
        if not cue or not cue[1]:
            continue
        word = f"cue {cue[1].lower()}{cue[2].strip()[0]}"
        if start in fixed:
            stop, kind = fixed[start]
            value = text[start:stop]
            if kind == "email":
                found.append((start, stop, value, [f"{word} run"], True))
            else:
                found.append((start, stop, value, [f"{word} {digits_of(value)}", f"{word} number"], True))
            continue
        number = _NUMBER.match(text, start)
        run = number or _RUN.match(text, start)
        while at < len(base) and base[at][1] <= start:
            at += 1
        if not run or start in starts or (at < len(base) and base[at][0] < run.end()):
            continue
        value = run[0]
        if number:
            patterns = [f"{word} {digits_of(value)}", f"{word} number"]
        else:
            patterns = [f"{word} {shape(value)}", f"{word} run"]
        found.append((start, run.end(), value, patterns, False))
    return found


SPAN = "struct<start:int,stop:int,kind:string>"
CANDIDATE = "struct<start:int,stop:int,value:binary,patterns:array<string>,seed:boolean>"


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, with its ``base`` spans and identifier ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            base, found = [], []
            for text in texts:
                fixed = base_spans(text or "")
                base.append([dict(start=s, stop=e, kind=k) for s, e, k in fixed])
                found.append(
                    [
                        dict(start=s, stop=e, value=sha256(v.encode()).digest()[:16], patterns=p, seed=x)
                        for s, e, v, p, x in candidates(text or "", fixed)
                    ]
                )
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
            candidate = pa.struct(
                [("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()),
                 ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())]
            )
            columns = [batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))]
            yield pa.record_batch(columns, ["row", "base", "found"])

    framed = docs.select(F.struct("*").alias("row"), F.col("text"))
    added = T.StructType.fromDDL(f"base array<{SPAN}>, found array<{CANDIDATE}>")
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))


FEW_WORDS = 100_000  # words of contexts that every task may hold: a few megabytes


def word_counts(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``word, occurrences`` of the lower-cased words in ``row.text``, for those in ``named`` at least.

    Up to ``FEW_WORDS`` of them are sent to all tasks, which count no others; beyond, all words are
    counted. Each task counts ahead.
    """
    wanted = [r[0] for r in named.limit(FEW_WORDS + 1).collect()]
    only = frozenset(wanted) if len(wanted) <= FEW_WORDS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            counts = Counter(
                w for t in texts if t for w in _WORD.findall(t.lower()) if only is None or w in only
            )
            yield pa.record_batch(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
            )

    counted = rows.select(F.col("row.text").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("occurrences"))


def reliable_patterns(
    found: DataFrame, rows: DataFrame, rounds: int = 3, threshold: float = 0.5, support: int = 3
) -> DataFrame:
    """Column ``pattern``: those whose reliability reaches ``threshold``.

    ``found`` has one row per candidate (``value``, ``patterns``, ``seed``). A value has the
    reliability of its best pattern, a seed 1; a pattern has the mean of its distinct values, if
    it has ``support`` of them at least. A pattern of a word of prose has the sum over its places
    instead, by all occurrences of the word in ``row.text`` of ``rows``: what is no candidate counts as 0.
    Patterns that no round can bring to the threshold go at once: those without enough values, and
    words with too few candidates. Each round is two aggregations over the edges.
    """
    edges = keep(
        found.where(F.size("patterns") > 0)
        .select("value", "seed", F.explode(F.array_distinct("patterns")).alias("pattern"))
        .groupBy("value", "pattern")
        .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("places")),
        "pattern-edges",
    )
    met = keep(
        edges.groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("values"), F.sum("places").alias("places"))
        .where(F.col("values") >= support)
        .withColumn("word", F.regexp_extract("pattern", "^(?:after|before) (\\S+) ", 1)),
        "met-patterns",
    )
    named = met.where("word <> ''")
    named = named.join(word_counts(rows, named.select("word").distinct()), "word").where(F.col("places") >= threshold * F.col("occurrences"))
    likely = met.where("word = ''").select("pattern", F.lit(None).cast("long").alias("occurrences"))
    likely = keep(likely.unionByName(named.select("pattern", "occurrences")), "likely-patterns")
    edges = keep(edges.join(likely, "pattern"), "likely-edges")
    seed = F.max(F.col("seed").cast("double"))
    values = keep(edges.groupBy("value").agg(seed.alias("trust")), "pattern-values")
    for _ in range(rounds):
        patterns = keep(
            edges.join(values, "value")
            .groupBy("pattern")
            .agg(
                F.coalesce(
                    F.sum(F.col("trust") * F.col("places")) / F.max("occurrences"), F.avg("trust")
                ).alias("trust")
            ),
            "patterns",
        )
        values = keep(
            edges.join(patterns.select("pattern", "trust"), "pattern", "left")
            .groupBy("value")
            .agg(F.greatest(seed, F.max(F.coalesce("trust", F.lit(0.0)))).alias("trust")),
            "pattern-values",
        )
    return patterns.where(F.col("trust") >= threshold).select("pattern")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, with ``base`` spans and all ``spans``.

    Null texts are empty. Repeated rows have the same spans each. The spans of kind ``id`` are the
    candidates that a reliable pattern extracts, unless they equal a base span.
    Lists of spans are as long as one text makes them; patterns reach the candidates by a join, so
    neither their number nor a pattern that holds a third of all candidates matters.
    """
    rows = keep(
        scanned(docs).withColumn("_uid", F.monotonically_increasing_id()), "scanned"
    )
    found = rows.where(F.size("found") > 0).select("_uid", F.explode("found").alias("c"))
    accepted = reliable_patterns(found.select("c.*"), rows)
    cued = found.select("_uid", "c.start", "c.stop", F.explode("c.patterns").alias("pattern"))
    more = (
        cued.join(accepted, "pattern", "left_semi")
        .groupBy("_uid")
        .agg(F.collect_set(F.struct("start", "stop", F.lit("id").alias("kind"))).alias("more"))
    )
    joined = rows.join(more, "_uid", "left")
    more = F.coalesce("more", F.expr(f"cast(array() as array<{SPAN}>)"))
    new = F.filter(
        more,
        lambda m: ~F.exists("base", lambda b: (b["start"] == m["start"]) & (b["stop"] == m["stop"])),
    )
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(
        F.transform(
            F.concat("base", new),
            lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")),
        )
    )
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return joined.select("row", "base", spans.alias("spans"))


def joined_spans(spans: str):
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    )


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced once, by the kind that starts first. ``n_chars``, if there,
    is counted anew; null texts stay null.
    """
    found = find(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            out = []
            for text, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
                if not spans:
                    out.append(text)
                    continue
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["stop"])
                out.append("".join([*parts, text[at:]]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    framed = found.select("row", F.col("row.text").alias("text"), "spans")
    schema = T.StructType([framed.schema["row"], T.StructField("text", T.StringType())])
    done = framed.mapInArrow(run, schema)
    return with_text(done, docs)


def with_text(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with the new ``text`` and its length in ``n_chars``."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.length("text").cast(kind).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`"))
    return done.select(*columns)
