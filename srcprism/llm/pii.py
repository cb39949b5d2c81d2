"""Personal data and the terms that give it away, with DataFrame functions only.

Base spans are found by patterns: e-mail addresses, IPv4 addresses, card numbers that pass the
Luhn check, and phone numbers. They are the protected entities, and so is each of the four kinds.
Information-theoretic sanitisation then looks at the other words of their texts, over the whole
corpus and counting different texts only. What an entity e is worth is its information content,
-log2 p(e); what a word t tells of it is their pointwise mutual information,
log2 p(t,e) / (p(t) p(e)). A word discloses the entity if it tells at least ``TOLD`` of its
content, and if chance is ruled out: beyond the first, the texts that hold both must bring
``EVIDENCE`` bits together. So a rare entity needs fewer texts, a frequent one more, and none is
too frequent. A word that only one text shares with a value is judged by the kind.
All spans of disclosing words join those of the documents that hold the entity.
``sanitised`` removes what tells almost all and generalises the rest.

The patterns are written so that each match takes time in proportion to its length: a match
starts at the start of a run or where the last one ended, and repetitions that nothing can
shorten are possessive, which also keeps long runs off the stack.

Edge cases: null and empty texts have no spans; repeated rows come out repeated and count as
one text of the corpus's support; a null doc_id is carried along; offsets are code points, ends
exclusive; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?+){16}", "phone": r"\+[0-9]"}
KINDS = [*PATTERNS, "term"]

#: Words considered: whole runs of so many letters.
WORD = r"\p{L}{4,}+"
#: Thresholds of disclosure: the part of an entity's content that a word tells, the bits of
#: evidence for it, and the part from which a word is removed.
TOLD, EVIDENCE, SURE = 0.5, 16.0, 0.95
#: Different texts that a term shares with an entity at least.
LEAST = 2

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _running(steps: Column, size: int = 64) -> Column:
    """Running totals of an array of int, in blocks so that long arrays stay cheap."""
    block = lambda i: F.floor(i / size).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), block(F.size(steps) - 1)), lambda b: _sum(F.slice(steps, b * size + 1, F.lit(size)))
    )
    before = lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b)))
    total = lambda p: F.transform(
        steps, lambda _, i: F.get(p, block(i)) + _sum(F.slice(steps, block(i) * size + 1, i % size + 1))
    )
    return _let(sums, lambda s: _let(before(s), total))


def located(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: their starts are running totals of what lies between and before."""

    def spans(m: Column, gaps: Column) -> Column:
        steps = F.transform(
            m, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0))
        )
        return _let(
            steps,
            lambda st: _let(
                _running(st),
                lambda at: F.transform(
                    m,
                    lambda x, i: F.struct(
                        F.lit(kind).alias("kind"),
                        F.get(at, i).alias("start"),
                        (F.get(at, i) + F.length(x)).alias("end"),
                        x.alias("value"),
                    ),
                ),
            ),
        )

    found = _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda g: spans(m, g))),
    )
    return F.coalesce(found, F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: _let(
            F.substr(digits, i, F.lit(1)).cast("int"),
            lambda d: F.when((F.length(digits) - i) % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9),
        ),
    )
    return _sum(doubled) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _keeps(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind, then start."""
    each = []
    for kind, pattern in PATTERNS.items():
        hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
        spans = F.filter(located(text, pattern, kind), _keeps(kind))
        each.append(F.when(hint, spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*each)


def _entities(found: Column, by_kind: bool) -> Column:
    name = (lambda f: f["kind"]) if by_kind else (lambda f: F.concat_ws(":", f["kind"], F.lower(f["value"])))
    return F.array_distinct(F.transform(found, name))


def _replaced(text: Column, marks: Column) -> Column:
    """``text`` with each mark (start, end, by) replaced; a mark that starts inside another is left out."""
    parts = F.aggregate(
        F.array_sort(marks),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, m: F.when(m["start"] < a["at"], a).otherwise(
            F.struct(
                m["end"].alias("at"),
                F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, m["start"] - a["at"]), m["by"])).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)),
    )
    return parts


def _marks(found: Column, by: Callable[[Column], Column]) -> Column:
    return F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), by(f).alias("by")))


def _corpus(docs: DataFrame) -> DataFrame:
    """Per row: a row id, a hash of the text, its base spans, and the words outside of them.

    Texts are kept where they hold a span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("found", base_spans(F.col("text")))
    outside = F.when(F.size("found") > 0, _replaced(F.col("text"), _marks(F.col("found"), lambda _: F.lit(" ")))).otherwise(F.col("text"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(WORD), F.lit(0)), F.lower))
    kept = F.when(F.size("found") > 0, F.col("text"))
    return common.cut(
        rows.withColumn("same", F.xxhash64("text"))
        .withColumn("rid", F.monotonically_increasing_id())
        .select("rid", "doc_id", "same", "found", words.alias("words"), kept.alias("text"))
    )


def _copies(corpus: DataFrame) -> DataFrame:
    """(rid) of the rows whose text an earlier row has."""
    first = corpus.groupBy("same").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
    return common.cut(corpus.select("rid", "same").join(first, "same").where("rid <> first").select("rid"))


def _held(corpus: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, words, entities) of the rows with entities, as far as these are considered; (entity,
    n_e): those, with the texts that hold them.

    An entity is a value or a whole kind. A value that one text holds has nothing to be measured
    by but its kind, so values of at least two texts are paired with words.
    """
    rows = corpus.where(F.size("found") > 0)
    named = rows.select("rid", F.explode(F.concat(_entities(F.col("found"), False), _entities(F.col("found"), True))).alias("entity"))
    named = common.cut(named)
    known = named.join(copies, "rid", "left_anti").groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= LEAST)
    known = common.cut(known)
    own = named.join(known.select("entity"), "entity").groupBy("rid").agg(F.collect_list("entity").alias("entities"))
    return common.cut(rows.select("rid", "words").join(own, "rid")), known


def _pairs(held: DataFrame) -> DataFrame:
    """(rid, entity, term): the words of each row with its entities."""
    return held.select("rid", "words", F.explode("entities").alias("entity")).select("rid", "entity", F.explode("words").alias("term"))


def disclosing(corpus: DataFrame, copies: DataFrame, held: DataFrame, known: DataFrame) -> DataFrame:
    """(entity, term, told): words that disclose an entity, counted over different texts."""
    joint = _pairs(held.join(copies, "rid", "left_anti")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= LEAST)
    joint = common.cut(joint)
    # Counted before the join: what is shuffled and joined is distinct words, not their uses.
    texts = corpus.join(copies, "rid", "left_anti")
    counts = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = F.lit(float(texts.count()))
    measured = joint.join(counts, "term").join(known, "entity")
    bits = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    told = bits / F.log2(total / F.col("n_e"))
    # An entity that all texts hold has no content to tell.
    enough = (F.col("n_e") < total) & ((F.col("n_te") - 1) * bits >= EVIDENCE) & (told >= TOLD)
    return measured.where(enough).select("entity", "term", told.alias("told"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found: base spans, terms: array of (start, end, told), text) for each row.

    text is null where there is no base span, and so no term.
    """
    corpus = _corpus(docs)
    copies = _copies(corpus)
    held, known = _held(corpus, copies)
    told = common.cut(disclosing(corpus, copies, held, known))
    hits = _pairs(held).join(told, ["entity", "term"]).groupBy("rid", "term").agg(F.max("told").alias("told"))
    # A document's own words only: their number is bounded by its length.
    shares = hits.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "told"))).alias("tells"))
    apart = lambda w: ~F.exists("found", lambda f: (f["start"] < w["end"]) & (w["start"] < f["end"]))
    part = lambda w: F.try_element_at(F.col("tells"), F.lower(w["value"]))
    spans = F.filter(located(F.col("text"), WORD, "term"), lambda w: part(w).isNotNull())
    spans = F.filter(spans, apart)
    spans = F.transform(spans, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), part(w).alias("told")))
    empty = F.array().cast("array<struct<start:int,end:int,told:double>>")
    terms = F.when(F.col("tells").isNotNull(), spans).otherwise(empty)
    # Rows without a span need no look-up: they are not moved.
    some = corpus.where(F.size("found") > 0).join(shares, "rid", "left").select("doc_id", "found", terms.alias("terms"), "text")
    return some.unionByName(corpus.where(F.size("found") == 0).select("doc_id", "found", empty.alias("terms"), "text"))


def sanitised() -> Column:
    """Of a row of ``find``: its text, base spans replaced by their kind, disclosing words removed
    or generalised; null where nothing is to be replaced."""
    marks = F.concat(
        _marks(F.col("found"), lambda f: F.concat(F.lit("["), F.upper(f["kind"]), F.lit("]"))),
        _marks(F.col("terms"), lambda t: F.when(t["told"] >= SURE, "").otherwise("[TERM]")),
    )
    return F.when(F.size("found") > 0, _replaced(F.col("text"), marks))
