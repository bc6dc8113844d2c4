"""Personal data: candidates from high-recall generators, boosted trees, calibrated thresholds; found and scored by JVM expressions only.

Four base kinds (email, ip, card, phone) are matched and validated; their spans always stay. Three
generators propose further spans, which may overlap each other and the base ones: opaque tokens (of
letters and digits), numbers (groups of digits), and values assigned to a name such as password. Each
candidate gets format features (length, shares of digits, capitals and hexadecimal signs, separators,
check digit) and context features (key words and signs around it). Boosted trees score it, and a
threshold per generator, calibrated on rows that the trees did not see, selects what is added besides
what the strict recogniser below knows, which is added always: a kind may be too rare to be learnt.

Training has no hand-made labels: candidates that a strict recogniser knows (a card number's check sum,
a plus sign before, the access-key and digest formats, a quote or an assignment before) are positives, all
others negatives. The features hold neither check sum nor the signs right before a candidate, so the trees
generalise to the same data written otherwise; that key words stand near, and a token's length and alphabet,
both sides see. Assignments are what their pattern says, so they are always added and never learnt from.
Training reads every candidate of every text, equal texts once: trees are grown on two thirds of the texts, thresholds
calibrated on the others. Candidates become bins of their features and are counted; each level of a tree is a pass that sums
gradients by node and bin, an aggregate of native expressions, and nothing that grows with the table reaches the driver.

Matches come from regexp_extract_all, their places from the lengths of what split() leaves between
them, added up in blocks. The expressions are the published ones with possessive quantifiers and a look-behind,
which change no match but keep the matcher linear on long runs and off the stack. A candidate's features are
bound once, however many trees read them.

Defined results: null and empty texts have no spans; a very long text is one row, and its time grows with its
length; ids play no part, so null, repeated and shared ones pass through; without candidates to train on only
recognised ones are added; an empty table gives none. Result columns replace input columns of their names;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm import boosting
from keystrata.llm.common import fresh, materialize, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("assigned", "number", "secret")
PRECISION = 0.98
#: Matches whose places are added up together.
BLOCK = 64
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "assigned": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"',;]{4,}+",
    "number": r"(?<![0-9A-Za-z.(+-])[0-9(][0-9 ().-]{4,}[0-9](?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{14,}+",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
NEEDS = {"email": "@", "phone": "+"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits' check sum is divisible by ten."""
    d = F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != "")
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    each = F.transform(d, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.when(F.size(d) > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(value)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def literal(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, kind: str) -> Column:
    """array<struct<kind, start, end, value, before, after>> of a pattern's matches in the text column, in order; places in code points.

    Element 0 of the gaps g stands before match 0 of m, so a match's place is what all before it take.
    It is added up within blocks (b: where their matches begin, counted from the block's begin) and
    over blocks (s: where they begin). One-element transforms bind each of these once.
    """
    t, pattern, block = f"`{text}`", literal(PATTERNS[kind]), str(BLOCK)
    found = f"regexp_extract_all({t}, {pattern}, 0)"
    if kind in NEEDS:
        found = f"CASE WHEN instr({t}, '{NEEDS[kind]}') > 0 THEN {found} ELSE CAST(array() AS array<string>) END"
    nothing = "named_struct('p', 0, 'out', CAST(array() AS array<int>))"
    part = lambda a: f"slice({a}, b * {block} + 1, {block})"
    lengths = f"filter(zip_with({part('x.m')}, {part('x.g')}, (m, g) -> CASE WHEN m IS NOT NULL THEN named_struct('g', length(g), 'm', length(m)) END), n -> n IS NOT NULL)"
    within = f"aggregate({lengths}, {nothing}, (acc, n) -> named_struct('p', acc.p + n.g + n.m, 'out', concat(acc.out, array(acc.p + n.g))))"
    begins = f"aggregate(x.b, {nothing}, (acc, b) -> named_struct('p', acc.p + b.p, 'out', concat(acc.out, array(acc.p))), acc -> acc.out)"
    at = f"get(x.s, CAST(i div {block} AS int)) + get(get(x.b, CAST(i div {block} AS int)).out, i % {block})"
    one = f"named_struct('kind', '{kind}', 'start', {at}, 'end', {at} + length(v), 'value', v, 'before', right(get(x.g, i), 24), 'after', left(get(x.g, i + 1), 8))"
    bound = f"transform(array(named_struct('m', {found})), x -> CASE WHEN size(x.m) > 0 THEN named_struct('m', x.m, 'g', split({t}, {pattern}, -1)) END)"
    blocks = f"transform(filter({bound}, x -> x IS NOT NULL), x -> named_struct('m', x.m, 'g', x.g, 'b', transform(sequence(0, CAST((size(x.m) - 1) div {block} AS int)), b -> {within})))"
    placed = f"transform({blocks}, x -> named_struct('m', x.m, 'g', x.g, 'b', x.b, 's', {begins}))"
    return F.expr(f"flatten(transform({placed}, x -> transform(x.m, (v, i) -> {one})))")


def features(c: Column) -> list[Column]:
    """Numbers of a candidate: format, then context."""
    v, n = c["value"], F.length(c["value"]).cast("double")
    core = F.regexp_replace(v, "^[^=:]*[=:][ ]?[\"']?", "")
    m = F.greatest(F.length(core), F.lit(1)).cast("double")
    share = lambda p: F.length(F.regexp_replace(core, p, "")) / m
    near = F.lower(c["before"])
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return [
        n,
        F.length(digits(v)).cast("double"),
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[^0-9a-f]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(core, ""))) / m,
        flag(v.rlike("[0-9][ .-][0-9]")),
        flag(v.contains("(")),
        flag(near.rlike("pass|key|secret|token|pwd|auth")),
        flag(near.rlike("tel|phone|call|fax|mobile|card|account|iban|ssn")),
        flag(c["after"].rlike("^[\"']")),
    ]


def known(c: Column) -> Column:
    """The strict recogniser of training labels."""
    v = c["value"]
    number = F.length(digits(v)).between(16, 19) & luhn(v) | c["before"].rlike(r"\+[0-9]{0,3} ?$") & F.length(digits(v)).between(7, 15)
    opaque = v.rlike("^AKIA[0-9A-Z]{16}$") | (v.rlike("^[0-9a-f]{40}$") & c["before"].rlike("[\"']$")) | c["before"].rlike("(?i)(password|passwd|pwd|secret|token)[\"']?[ ]?[=:][ ]?[\"']?$")
    return F.when(c["kind"] == "number", number).when(c["kind"] == "secret", opaque).otherwise(True)


def candidates(text: str) -> Column:
    return F.concat(*(matches(text, k) for k in ADDED))


Model = tuple[float, list[boosting.Tree], dict[str, float]]


def bins(f: list[Column]) -> list[Column]:
    """The bin of each feature: how many of its CUTS are less than it."""
    whole = lambda x: F.when(x <= 64, x).otherwise(F.least(64 + F.ceil(F.log2(x / 64)), F.lit(80)))
    share = lambda x: F.least(F.ceil(x * 64 - 0.5), F.lit(64))
    return [(whole if j < 2 else share if j < 8 else lambda x: x)(x).cast("int") for j, x in enumerate(f)]


#: Thresholds that the trees choose among, whatever the data: whole numbers to 64 and powers of two above, 64ths, flags.
CUTS = [np.array([*np.arange(64) + 0.5, *64.0 * 2 ** np.arange(16)])] * 2 + [(np.arange(64) + 0.5) / 64] * 6 + [np.array([0.5])] * 5


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Base, trees and thresholds, from every candidate of every different text; candidates of equal bins are one weighted row."""
    texts = docs.select(text_of(text_col).alias("t")).filter(F.col("t").rlike("[0-9]")).withColumn("h", F.xxhash64("t"))
    learnt = F.concat(*(matches("t", k) for k in ADDED[1:]))
    short = lambda c: F.struct((c["kind"] == ADDED[1]).cast("int").alias("k"), F.coalesce(known(c), F.lit(False)).cast("int").alias("y"), F.array(*bins(features(c))).alias("b"))
    found = texts.select("h", F.transform(learnt, short).alias("c")).filter(F.size("c") > 0).groupBy("h").agg(F.any_value("c").alias("c"))
    each = found.select((F.pmod("h", F.lit(3)) == 0).alias("test"), F.explode("c").alias("c")).groupBy("test", "c.k", "c.y", "c.b").agg(F.count(F.lit(1)).alias("w"))
    groups = materialize(each, "candidates")
    n, ones = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0))).first()
    if not ones:
        return 0.0, [], dict.fromkeys(ADDED, 1.0)
    base, trees = boosting.fit_groups(groups.filter("NOT test"), [len(c) + 1 for c in CUTS], 24, 3, least=max(2, min(20, n // 50)))

    step = F.least(F.greatest(F.floor(F.expr(boosting.log_odds(base, trees, "b")) * STEPS), F.lit(-MOST)), F.lit(MOST - 1)) + MOST
    wrong_right = np.zeros((2, 2, 2 * MOST), np.int64)
    for r in groups.filter("test").groupBy("k", "y", step.cast("int").alias("step")).agg(F.sum("w").alias("w")).collect():
        wrong_right[r.k, r.y, r.step] = r.w
    return base, [boosting.with_cuts(t, CUTS) for t in trees], {ADDED[0]: 1.0} | {kind: threshold(*wrong_right[int(kind == ADDED[1])]) for kind in ADDED[1:]}


#: Log-odds are counted in so many steps a unit, up to MOST steps from zero.
STEPS, MOST = 64, 2048


def threshold(wrong: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least score from which on that share of the candidates, counted by steps of log-odds, is right; above 1 if there is none."""
    good, every = np.cumsum(right[::-1]), np.cumsum((wrong + right)[::-1])
    ok = np.flatnonzero((good >= precision * every) & ((wrong + right)[::-1] > 0))
    return float(1 / (1 + np.exp(-(MOST - 1 - ok[-1]) / STEPS))) - 1e-12 if len(ok) else 2.0


def selected(model: Model, rich: str) -> Column:
    """Of candidates (with sure and features f) what the recogniser knows, whether or not its kind was learnt, and what scores enough; a model without trees and limits above 1 selects nothing."""
    base, trees, limits = model
    if not trees:
        test = "c.sure" if min(limits.values()) <= 1 else "false"
    else:
        score = boosting.log_odds(base, trees, "c.f")
        limit = " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in limits.items())
        test = f"c.sure OR 1 / (1 + exp(-({score}))) >= CASE c.kind {limit} END"
    return F.expr(f"transform(filter(`{rich}`, c -> {test}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))")


def spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with base and added: array<struct<kind, start, end>> by kind and start; a base span that holds an added one keeps it out."""
    kept = [c for c in docs.columns if c.lower() not in ("base", "added")]
    t, rich = fresh([*kept, "base", "added"], "t", "rich")
    own = [F.col(f"`{c}`") for c in kept]
    base = F.concat(*(F.filter(matches(t, k), partial(lambda k, c: valid(k, c["value"]), k)) for k in BASE))
    bare = F.transform(base, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    out = docs.select(*own, text_of(text_col).alias(t)).withColumn("base", bare)
    free = F.filter(candidates(t), lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    wide = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.coalesce(known(c), F.lit(False)).alias("sure"), *([F.array(*features(c)).alias("f")] if model[1] else []))
    return out.withColumn(rich, F.transform(free, wide)).withColumn("added", selected(model, rich)).select(*own, "base", "added")


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; spans that overlap become one, named by its first."""
    found = spans(docs, model, text_col)
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merge(acc: Column, c: Column) -> Column:
        end, last = -c["back"], F.element_at(acc, -1)
        fresh = F.concat(acc, F.array(F.struct(c["start"].alias("start"), end.alias("end"), c["kind"].alias("kind"))))
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))))
        return F.when((F.size(acc) > 0) & (c["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))), wider).otherwise(fresh)

    text = F.col(text_col)
    cut = F.aggregate(
        F.aggregate(every, empty, merge),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]")).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    changed = F.when(F.size("base") + F.size("added") > 0, cut).otherwise(text)
    return found.withColumn(text_col, changed).drop("base", "added")
