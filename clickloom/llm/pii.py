"""Personal data: patterns of form, and a bootstrap over the words that stand before them.

Spans that a strict form proves (emails, IP addresses, payment cards, phone
numbers) are seeds. The words before a seed are lexical patterns. All tokens
that look like identifiers, proven or not, form a graph of (pattern, value)
edges; a pattern is scored by how much of what follows it is believed to be of
a kind, an unproven value by the patterns it follows, in rounds, until nothing
new is believed. Unproven values believed in, after patterns believed in, are
further spans. All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle

KINDS = ("email", "ip", "card", "phone")

# Each form is found leftmost, without overlap, as the plain pattern beside it
# would be; \G and the look-behind keep long runs from being tried at every
# character, possessive quantifiers from being given back.
FORMS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a form to occur in it.
_TRIGGERS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Tokens that look like identifiers: something at something, or a run of digits and separators.
TOKEN = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-][A-Za-z0-9.-]*+"
    r"|(?<![A-Za-z0-9])[+(]?[0-9](?:[().:-]|\x20(?=[0-9(])|[0-9]){5,}+(?![A-Za-z])"
)
# What an unproven token must look like to be taken for a kind.
SHAPES = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"^[0-9]{1,4}([.:][0-9]{1,4}){3}$",
    "card": r"^([^0-9]*[0-9]){13,19}[^0-9]*$",
    "phone": r"^([^0-9]*[0-9]){7,15}[^0-9]*$",
}
# A pattern is believed from this share of a kind among at least so many different values.
PATTERN_SHARE, PATTERN_VALUES = 0.8, 5
# An unproven value is believed from this score.
BELIEF = 0.8
# Scores that rise by less in a round have come to rest.
TINY = 1e-9
# Characters of text before a token in which its words are looked for.
REACH = 80
_BLOCK = 128


def spans_of(text: Column, form: str, trigger: str = "") -> Column:
    """Matches of a form as array<struct<start, end, value, before>>: code points, end exclusive.

    ``before`` is the end of the text between the match before and this one.
    """
    has = F.contains(text, F.lit(trigger)) if trigger else F.lit(True)
    empty = F.array().cast("array<string>")
    values = F.when(has, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(empty)
    gaps = F.when(has, F.split(text, form, -1)).otherwise(empty)
    # One gap more than matches: the last pair has no match and goes.
    pairs = F.zip_with(
        values, gaps,
        lambda value, gap: F.struct(
            value.alias("value"), F.length(value).alias("size"), F.length(gap).alias("gap"),
            F.substring(gap, -REACH, REACH).alias("before"),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return _let(pairs, lambda p: F.when(F.size(p) > 1, _placed(F.slice(p, F.lit(1), F.size(p) - 1))).otherwise(none))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, however often and wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(pairs: Column) -> Column:
    """Running sums of gaps and sizes, in blocks, so that many matches take few array copies."""

    def cut(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int"))
        return F.transform(blocks, lambda b: F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)))

    kind = "array<struct<start:int,end:int,value:string,before:string>>"

    def inside(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(state: Column, x: Column) -> Column:
            first = state["at"] + x["gap"]
            span = F.struct(
                first.alias("start"), (first + x["size"]).alias("end"), x["value"].alias("value"),
                x["before"].alias("before"),
            )
            return F.struct((first + x["size"]).alias("at"), F.array_append(state["out"], span).alias("out"))

        return F.aggregate(block, start, step)

    return _let(F.transform(_let(pairs, cut), inside), _joined)


def _joined(done: Column) -> Column:
    """The blocks' spans in one array, each block moved behind those before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
    offsets = F.aggregate(
        done, zero,
        lambda state, b: F.struct(
            (state["at"] + b["at"]).alias("at"), F.array_append(state["offsets"], state["at"]).alias("offsets")
        ),
        lambda state: state["offsets"],
    )
    moved = F.zip_with(
        done, offsets,
        lambda b, offset: F.transform(
            b["out"],
            lambda s: F.struct(
                (s["start"] + offset).alias("start"), (s["end"] + offset).alias("end"), s["value"].alias("value"),
                s["before"].alias("before"),
            ),
        ),
    )
    return F.flatten(moved)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others: every second from the right doubled, nines cast out."""

    def total(backwards: Column) -> Column:
        def add(state: Column, place: Column) -> Column:
            digit = F.substring(backwards, place, F.lit(1)).cast("int")
            twice = digit * 2
            return state + F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add)

    return _let(F.reverse(digits), total) % 10 == 0


def proven(text: Column, kind: str) -> Column:
    """Spans of a kind whose form holds; matches that fail its check are dropped."""
    found = spans_of(text, FORMS[kind], _TRIGGERS[kind])
    if kind == "ip":
        return F.filter(found, lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        long = F.filter(found, lambda s: F.length(_digits(s["value"])).between(16, 19))
        return F.filter(long, lambda s: luhn(_digits(s["value"])))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(_digits(s["value"])).between(8, 15))
    return found


def _context(before: Column) -> Column:
    """The last one and the last two words before a token, as patterns; none where no word with a letter is."""
    plain = F.trim(F.regexp_replace(F.lower(before), r"[^\p{L}\p{N}]+", " "))
    one, two = F.substring_index(plain, " ", -1), F.substring_index(plain, " ", -2)
    return F.filter(F.array_distinct(F.array(one, two)), lambda p: p.rlike(r"\p{L}"))


def _scan(docs: DataFrame) -> DataFrame:
    """Each document's proven spans by kind, and its identifier-like tokens."""
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))
    for kind in KINDS:
        rows = rows.withColumn(kind, proven(F.col("text"), kind))
    rows = rows.withColumn("tokens", spans_of(F.col("text"), TOKEN)).drop("text")
    for kind in KINDS:
        rows = rows.withColumn(kind, F.transform(kind, lambda s: F.struct(s["start"], s["end"])))
    return rows


def _kind_of(token: Column) -> Column:
    """The kind of a proven span that overlaps a token, by the order of kinds; null if none does."""

    def overlaps(kind: str) -> Column:
        return F.exists(kind, lambda s: (s["start"] < token["end"]) & (s["end"] > token["start"]))

    found = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        found = F.when(overlaps(kind), kind).otherwise(found)
    return found


def _edges(scanned: DataFrame) -> DataFrame:
    """(k1, k2, start, end, value, kind, patterns): one row per identifier-like token."""
    tokens = F.transform(
        "tokens",
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value"),
            _kind_of(t).alias("kind"), _context(t["before"]).alias("patterns"),
        ),
    )
    return scanned.where(F.size("tokens") > 0).select("k1", "k2", F.explode(tokens).alias("t")).select("k1", "k2", "t.*")


def _shaped(value: Column, kind: str) -> Column:
    return value.rlike(SHAPES[kind])


def believed(
    graph: DataFrame, share: float = PATTERN_SHARE, values: int = PATTERN_VALUES, belief: float = BELIEF,
) -> DataFrame:
    """(pattern, value, kind): unproven values and the patterns they are believed after.

    ``graph`` has an edge (pattern, value, kind) per pattern and value, kind null
    where nothing proves the value. In each round a pattern's score for a kind
    is the belief in the values after it over their number, one doubt added, and
    counts from ``share`` and ``values`` different values on; a value's is the
    chance that not all patterns before it err. Scores only rise from round to
    round. Rounds end when no further pattern counts and no further value is
    believed, and none would if all believed values were certain, or else when
    scores rise no more.
    """
    known = graph.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    sizes = graph.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    pairs = graph.select("pattern", "value").distinct()
    doubtful = graph.where("kind IS NULL").select("pattern", "value").distinct()
    shaped = F.lit(False)
    for kind in KINDS:
        shaped = shaped | ((F.col("kind") == kind) & _shaped(F.col("value"), kind))

    def judged(scores: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """A round from these scores: what is found, what is believed, how many patterns count and values are believed."""
        patterns = (
            pairs.join(scores, "value").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
            .join(sizes, "pattern")
            .withColumn("trust", F.col("mass") / (F.col("n") + 1.0))
            .where((F.col("trust") >= share) & (F.col("support") >= values))
        )
        patterns = settle(patterns, "patterns")
        found = settle(doubtful.join(patterns, "pattern").where(shaped).select("pattern", "value", "kind", "trust"), "found")
        all_err = F.exp(F.sum(F.log(F.lit(1.0) - F.least("trust", F.lit(1 - 1e-9)))))
        new = found.groupBy("value", "kind").agg((F.lit(1.0) - all_err).alias("score")).where(F.col("score") >= belief)
        new = settle(new.join(known, ["value", "kind"], "left_anti"), "believed")
        return found, new, (patterns.count(), new.count())

    found, new, size = judged(known)
    undecided = None
    while size[1]:
        before, least = new, size
        found, new, size = judged(known.unionByName(before))
        # Both sets only grow, so that equal counts are equal sets.
        if size[0] > least[0] or size[1] > least[1]:
            undecided = None
            continue
        if undecided is None:
            undecided = judged(known.unionByName(new.withColumn("score", F.lit(1.0))))[2] != size
        if not undecided:
            break
        lower = before.withColumnRenamed("score", "lower")
        rise = new.join(lower, ["value", "kind"]).agg(F.max(F.col("score") - F.col("lower"))).first()[0]
        if rise is None or rise < TINY:
            break
    return found.join(new.select("value", "kind"), ["value", "kind"], "left_semi").select("pattern", "value", "kind")


def find(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, proven and found spans.

    ``proven`` and ``found`` are arrays of (kind, start, end) in code points, end
    exclusive, ordered by kind as in ``KINDS``, then start. Proven spans follow
    from form alone. Found ones do not overlap them, and depend on the whole
    table; a token believed to be of two kinds takes the first. Null text is
    empty and has none. Repeated rows come out as often as they came in, all
    with the same spans; no documents, no rows. Columns other than doc_id and
    text are not read.
    """
    scanned = settle(_scan(docs), "scanned")
    tokens = _edges(scanned)
    graph = tokens.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(
        F.max("kind").alias("kind")
    )
    sure = settle(believed(settle(graph, "pattern-graph"), **settings).distinct(), "unseen")
    unseen = tokens.where("kind IS NULL").withColumn("pattern", F.explode("patterns"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    hits = (
        unseen.drop("kind").join(sure, ["pattern", "value"])
        .groupBy("k1", "k2", "start", "end").agg(F.min_by("kind", rank).alias("kind"))
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    )
    base = F.concat(*map(_named, KINDS))
    joined = scanned.select("doc_id", "k1", "k2", base.alias("proven")).join(hits, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("doc_id", "proven", in_order(F.coalesce("found", none)).alias("found"))


def _named(kind: str) -> Column:
    return F.transform(
        kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def in_order(spans: Column) -> Column:
    """Spans by kind as in ``KINDS``, then start, then end."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"),
            s["end"].alias("end"), s["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
