"""Personal data: pattern spans, and terms that give protected values away.

Everything runs as DataFrame expressions. Spans are in code points, the end
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import bounded_side, set_aside
from tillroll.session import freeze, release

#: Fixed patterns, in the order in which kinds are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")

# The same matches without backtracking: a run is tried from its start or
# from the end of the match before, and repeats give nothing back.
_FAST = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@"
        r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
# A cheap test that every text with such a match passes.
_HINT = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda text: text.contains("+"),
}

#: Different texts that must hold both the term and the value.
LEAST_TOGETHER = 2
#: Texts that share more telling terms of a value than this may be near copies.
MANY_TERMS = 16
#: A term is disclosing when it tells at least this share of the value's information.
DISCLOSURE = 0.8
# Far above the rounding of the measure: bounds on it drop nothing that reaches it.
_SLACK = 1e-6
_TERM = r"[\p{L}\p{N}]++"
# Stands for a base span while the terms around it are listed.
_HOLE = "\ue000"

_SPAN = "struct<start: int, end: int, value: string>"
_PLACES = "array<struct<start: int, end: int>>"


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Spans of ``found``, all matches of ``pattern`` in ``text``, in order.

    The text between two matches is what splitting at the pattern leaves, so the
    places follow from the lengths of both. The sum runs on through the matches.
    """
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"),
        found.alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to tens."""
    digits = F.transform(
        F.split(F.reverse(_digits(value)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0))
    )
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Leading zeros aside, a part of four digits or more is above 255.
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        small = lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(parts, small)
    size = F.length(_digits(value))
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return size.between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in ``text``: leftmost matches that pass the kind's test."""
    pattern = _FAST[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.filter(_places(text, pattern, found), lambda s: _holds(kind, s["value"]))
    return F.when(_HINT[kind](text), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _all_terms(text: Column) -> Column:
    """All terms of ``text`` in lower case, once each."""
    found = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def _free_terms(text: Column, base: Column) -> Column:
    """Terms anywhere in ``text`` that overlap no span of ``base``."""

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"]))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.concat(done["rest"], gap, F.lit(_HOLE)).alias("rest"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("rest"))
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["end"])))
    done = F.aggregate(ordered, start, step)
    rest = F.concat(done["rest"], F.substring(text, done["at"] + 1, F.length(text)))
    letters = r"[\p{L}\p{N}]*+"
    return _all_terms(F.regexp_replace(rest, f"{letters}(?:{_HOLE}{letters})++", " "))


def _places_of(text: Column, wanted: Column) -> Column:
    """Start and end of every term of ``text`` that is in ``wanted``."""
    found = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, _TERM, -1), 1, F.size(found)), F.length)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        hit = F.array_contains(wanted, F.lower(pair["value"]))
        spans = F.when(hit, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every whole text, and the terms of texts that have some.

    Columns: ``id_col``, ``text_hash``, ``base`` (kind, start, end, value) and ``beside``,
    the distinct terms of the whole text, in lower case. Terms that overlap a base
    span are left out: it covers them. A null text has no spans. Nothing but this
    leaves the scan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_kind(kind: str) -> Column:
        parts = ("start", "end", "value")
        return F.transform(
            base_spans(text, kind),
            lambda s: F.struct(F.lit(kind).alias("kind"), *[s[p].alias(p) for p in parts]),
        )

    base = F.concat(*map(of_kind, PATTERNS))
    beside = F.when(F.size("base") > 0, _free_terms(text, F.col("base"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        docs.select(id_col, text_col)
        .withColumn("text_hash", F.xxhash64(text))
        .withColumn("base", base)
        .withColumn("beside", beside)
        .drop(text_col)
    )


def disclosing_terms(
    docs: DataFrame,
    found: DataFrame,
    least_together: int = LEAST_TOGETHER,
    disclosure: float = DISCLOSURE,
    text_col: str = "text",
) -> DataFrame:
    """Terms that give a protected value away: ``kind``, ``value``, ``term``, ``told``.

    Over all documents, p(v) is the share that holds the value, p(t) the share that
    holds the term, and p(t, v) the share that holds both, at any distance. The
    pointwise mutual information log(p(t, v) / (p(t) p(v))) is what the term tells of
    the value, out of -log p(v) that there is to tell; the ratio is ``told``. It
    is 1 for a term met only with the value. Terms below ``disclosure`` are left,
    as are those met with the value in fewer than ``least_together`` different
    texts: one meeting is no estimate, and copies of a text, exact or near, are not more
    of them.

    Values are told apart by what they name: cards and phones by their digits, addresses
    of machines by their numbers, mail without regard to case. Copies of a text are
    counted first, so each text is paired once. Terms are counted in the texts with values
    before any pair is made: one in fewer texts than asked for, or already in too many for
    the measure to be reached, makes none. The rest of the corpus is then searched for
    the terms of the pairs alone.
    """
    pair = ["kind", "value", "term"]
    holding = found.filter(F.size("base") > 0)
    texts = holding.groupBy("text_hash").agg(
        F.count(F.lit(1)).alias("copies"),
        F.first("base").alias("base"),
        F.first("beside").alias("beside"),
    )
    texts = freeze(texts, "texts-with-values")
    held = F.array_distinct(
        F.transform(
            "base",
            lambda s: F.struct(
                s["kind"].alias("kind"), _named(s["kind"], s["value"]).alias("value")
            ),
        )
    )
    values = texts.select("text_hash", "copies", F.explode(held).alias("held")).select(
        "text_hash", "copies", "held.*"
    )
    holders = freeze(
        values.groupBy("kind", "value")
        .agg(F.sum("copies").alias("holders"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= least_together)
        .drop("texts"),
        "holders",
    )
    n = F.lit(float(max(1, found.count())))

    def told(together: Column, seen: Column, of: Column) -> Column:
        return F.ln(together * n / (seen * of)) / F.greatest(F.ln(n / of), F.lit(1e-9))

    shared = values.join(holders, ["kind", "value"]).select(
        "text_hash", "copies", "kind", "value", "holders"
    )
    most = shared.groupBy("text_hash").agg(F.max("holders").alias("most"))
    beside = texts.join(most, "text_hash").select(
        "text_hash", "most", F.explode("beside").alias("term")
    )
    met = (
        texts.select("copies", F.explode("beside").alias("term"))
        .groupBy("term")
        .agg(F.sum("copies").alias("met"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= least_together)
        .select("term", "met")
    )
    # The best a term can reach here is with all holders of the value, seen nowhere else.
    able = told(F.col("most"), F.col("met"), F.col("most")) >= disclosure - _SLACK
    near = beside.join(met, "term").filter(able | (F.col("met") <= F.col("most")))
    pairs = (
        shared.join(near.select("text_hash", "term", "met"), "text_hash")
        .groupBy(*pair)
        .agg(
            F.sum("copies").alias("together"), F.count(F.lit(1)).alias("texts"),
            F.first("holders").alias("holders"), F.first("met").alias("met"),
        )
        .filter(F.col("texts") >= least_together)
        .filter(told(F.col("together"), F.col("met"), F.col("holders")) >= disclosure - _SLACK)
    )
    pairs = freeze(pairs, "pairs")
    asked = freeze(pairs.select("term").distinct(), "asked-terms")
    seen = (
        docs.select(F.explode(_all_terms(F.coalesce(text_col, F.lit("")))).alias("term"))
        .join(bounded_side(asked, "term"), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    measured = pairs.drop("met").join(seen, "term").withColumn(
        "told", told(F.col("together"), F.col("seen"), F.col("holders"))
    )
    reached = freeze(
        measured.filter(F.col("told") >= disclosure).select(*pair, "told"), "reached"
    )
    result = freeze(_from_unlike_texts(reached, shared, texts, least_together), "telling")
    for done in (pairs, asked, reached, texts, holders):
        release(done)
    return result


def _from_unlike_texts(
    reached: DataFrame, shared: DataFrame, texts: DataFrame, least_together: int
) -> DataFrame:
    """The terms whose meetings with the value are not those of near copies of one text.

    A text that shares many telling terms of a value with others is named by the least
    hash among them, which near copies have in common; any other text is its own.
    Texts of the same name count once, and a quarter of all must lie outside the
    most frequent name: however large a family of copies, it is one piece of evidence.
    """
    pair = ["kind", "value", "term"]
    terms = freeze(reached.select("term").distinct(), "reached-terms")
    heard = texts.select("text_hash", F.explode("beside").alias("term")).join(
        bounded_side(terms, "term"), "term"
    )
    met = freeze(
        shared.select("text_hash", "kind", "value")
        .join(heard, "text_hash")
        .join(reached.select(*pair), pair)
        .select("text_hash", *pair),
        "met-terms",
    )
    names = met.groupBy("text_hash", "kind", "value").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("term")).alias("least")
    )
    names = names.withColumn(
        "name", F.when(F.col("m") > MANY_TERMS, F.col("least")).otherwise(F.col("text_hash"))
    )
    alike = met.join(
        names.select("text_hash", "kind", "value", "name"), ["text_hash", "kind", "value"]
    ).groupBy(*pair, "name").agg(F.count(F.lit(1)).alias("c"))
    of_pair = alike.groupBy(*pair).agg(F.sum("c").alias("all"), F.max("c").alias("most"))
    outside = F.col("all") - F.col("most")
    unlike = (outside + 1 >= least_together) & (
        (4 * outside >= F.col("all")) | F.lit(least_together < 2)
    )
    return reached.join(of_pair.filter(unlike).select(*pair), pair)


def _named(kind: Column, value: Column) -> Column:
    """What a value names, whatever its spelling."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    numbers = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    return (
        F.when(kind.isin("card", "phone"), digits)
        .when(kind == "ip", numbers)
        .otherwise(F.lower(value))
    )


def personal_data(
    docs: DataFrame,
    least_together: int = LEAST_TOGETHER,
    disclosure: float = DISCLOSURE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base spans and disclosing spans of every row of ``docs``.

    Columns: ``id_col``, ``text_hash``, ``base`` and ``terms`` (start and end, in order,
    without repeats). A term that gives a value away is a span wherever it stands, in
    every document, outside base spans. Rows that repeat have equal results. The
    base spans are found in one pass, when called, and kept in the shared folder.
    """
    found = freeze(find_personal_data(docs, id_col, text_col), "personal-data")
    telling = disclosing_terms(docs, found, least_together, disclosure, text_col)
    none = F.array().cast(_PLACES)
    if telling.isEmpty():
        return found.select(id_col, "text_hash", "base", none.alias("terms"))
    terms = freeze(telling.select("term").distinct(), "terms")
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = (
        docs.select(F.xxhash64(text).alias("_hash"), F.explode(_all_terms(text)).alias("term"))
        .join(bounded_side(terms, "term"), "term", "left_semi")
        .groupBy("_hash")
        .agg(F.collect_set("term").alias("_wanted"))
    )
    met = freeze(met, "texts-with-terms")
    # Places are found where the text is; rows with the same text take them from one of it.
    spans = (
        docs.select(F.xxhash64(text).alias("_hash"), text.alias("_text"))
        .join(bounded_side(met, "_wanted"), "_hash")
        .select("_hash", _places_of(F.col("_text"), F.col("_wanted")).alias("_terms"))
        .groupBy("_hash")
        .agg(F.first("_terms").alias("_terms"))
    )
    free = F.filter(
        F.coalesce("_terms", none),
        lambda t: ~F.exists(
            F.col("base"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])
        ),
    )
    return found.join(spans, F.col("text_hash") == F.col("_hash"), "left").select(
        id_col, "text_hash", "base", free.alias("terms")
    )


def span_report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, and the spans as text with a checksum of the base ones."""

    def listed(kind: Column | str, s: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.concat_ws(":", kind, s["start"], s["end"])

    base = F.transform("base", lambda s: listed(s["kind"], s))
    terms = F.transform("terms", lambda s: listed("term", s))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return spans.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in PATTERNS],
        F.size("terms").cast("bigint").alias("n_term"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def sanitise(
    docs: DataFrame,
    least_together: int = LEAST_TOGETHER,
    disclosure: float = DISCLOSURE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with base spans masked and disclosing terms generalised.

    A base span becomes its kind in angle brackets. A disclosing number becomes
    ``<NUMBER>`` and a capitalised word ``<NAME>``; any other disclosing term is
    removed. Of overlapping spans the first names the whole. All columns are kept; only
    the text changes, and a null text stays null.
    """
    docs, restored = set_aside(docs, {"doc_id": id_col, "text": text_col})
    spans = personal_data(docs, least_together, disclosure)
    marked = (
        spans.filter((F.size("base") > 0) | (F.size("terms") > 0))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "base", "terms")
        .dropDuplicates(["_id", "_hash"])
        .withColumn(
            "_spans",
            F.array_sort(
                F.concat(
                    F.transform("base", lambda s: F.struct(
                        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
                    F.transform("terms", lambda s: F.struct(
                        s["start"].alias("start"), s["end"].alias("end"),
                        F.lit("term").alias("kind"))),
                )
            ),
        )
        .select("_id", "_hash", "_spans")
    )
    text = F.col("text")

    def between(start: Column, end: Column) -> Column:
        return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))

    def step(done: Column, s: Column) -> Column:
        term = between(s["start"], s["end"])
        general = (
            F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            .when(term.rlike(r"^\p{N}+$"), "<NUMBER>")
            .when(term.rlike(r"^\p{Lu}"), "<NAME>")
            .otherwise("")
        )
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(done["text"], between(done["at"], s["start"]), general))
            .otherwise(done["text"])
            .alias("text"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    done = F.aggregate("_spans", start, step)
    clean = F.concat(done["text"], between(done["at"], F.length(text)))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")
    )
    made = docs.join(marked, same, "left")
    return restored(made.withColumn("text", F.when(F.col("_spans").isNull(), text).otherwise(clean)))
